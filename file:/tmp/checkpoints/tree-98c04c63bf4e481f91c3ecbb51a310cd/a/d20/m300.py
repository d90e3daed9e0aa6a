x300