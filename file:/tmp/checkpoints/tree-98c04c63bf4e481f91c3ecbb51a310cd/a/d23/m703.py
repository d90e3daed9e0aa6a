x703