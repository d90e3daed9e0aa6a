x33