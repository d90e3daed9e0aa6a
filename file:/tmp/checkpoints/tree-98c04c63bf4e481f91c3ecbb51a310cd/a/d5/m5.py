x5