x9