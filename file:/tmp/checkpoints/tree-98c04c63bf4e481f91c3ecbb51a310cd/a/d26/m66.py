x66