x147