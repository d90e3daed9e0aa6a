x628