no