x448