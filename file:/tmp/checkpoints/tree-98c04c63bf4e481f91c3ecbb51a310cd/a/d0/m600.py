x600