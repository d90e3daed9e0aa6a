x616