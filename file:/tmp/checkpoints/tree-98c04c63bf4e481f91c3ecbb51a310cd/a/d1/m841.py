x841