x201