x323