x480