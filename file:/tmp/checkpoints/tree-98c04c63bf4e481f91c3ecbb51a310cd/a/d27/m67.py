x67