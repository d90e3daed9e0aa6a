x498