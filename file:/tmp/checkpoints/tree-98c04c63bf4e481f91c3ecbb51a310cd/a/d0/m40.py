x40