x726