x630