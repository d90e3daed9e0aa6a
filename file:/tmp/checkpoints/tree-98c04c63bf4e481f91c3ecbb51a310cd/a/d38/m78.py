x78