x26