x2