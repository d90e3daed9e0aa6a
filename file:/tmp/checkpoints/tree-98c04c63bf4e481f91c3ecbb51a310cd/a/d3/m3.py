x3