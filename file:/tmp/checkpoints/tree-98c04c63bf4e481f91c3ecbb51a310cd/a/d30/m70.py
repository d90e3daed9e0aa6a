x70