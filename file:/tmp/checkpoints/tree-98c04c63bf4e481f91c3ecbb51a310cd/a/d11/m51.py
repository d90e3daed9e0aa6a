x51