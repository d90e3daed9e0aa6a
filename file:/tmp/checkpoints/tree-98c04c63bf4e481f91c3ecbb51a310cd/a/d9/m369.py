x369