x18