x700