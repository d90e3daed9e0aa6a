x1