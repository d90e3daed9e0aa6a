x142