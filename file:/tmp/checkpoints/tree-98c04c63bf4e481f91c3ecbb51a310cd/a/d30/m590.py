x590