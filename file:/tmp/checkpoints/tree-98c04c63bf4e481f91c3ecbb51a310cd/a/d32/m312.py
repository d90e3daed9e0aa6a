x312