yes