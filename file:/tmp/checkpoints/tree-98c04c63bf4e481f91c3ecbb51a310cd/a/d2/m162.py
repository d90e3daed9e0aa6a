x162