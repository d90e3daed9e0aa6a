x84