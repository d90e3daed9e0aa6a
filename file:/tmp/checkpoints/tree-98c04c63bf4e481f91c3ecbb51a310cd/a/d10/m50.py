x50