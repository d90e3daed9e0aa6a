x282