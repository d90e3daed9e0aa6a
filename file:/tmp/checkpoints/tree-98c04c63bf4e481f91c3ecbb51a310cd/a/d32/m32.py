x32