x177