x16