x58