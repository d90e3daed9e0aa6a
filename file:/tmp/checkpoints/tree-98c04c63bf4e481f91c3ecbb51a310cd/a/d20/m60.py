x60