x0