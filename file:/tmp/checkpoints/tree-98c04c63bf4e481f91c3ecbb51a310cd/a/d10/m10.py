x10