x80