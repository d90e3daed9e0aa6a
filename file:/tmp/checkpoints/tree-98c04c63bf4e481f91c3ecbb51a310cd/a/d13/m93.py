x93