x36