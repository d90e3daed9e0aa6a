x7