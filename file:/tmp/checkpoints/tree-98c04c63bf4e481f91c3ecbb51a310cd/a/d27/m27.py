x27