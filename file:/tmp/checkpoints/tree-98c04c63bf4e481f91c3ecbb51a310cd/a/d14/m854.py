x854