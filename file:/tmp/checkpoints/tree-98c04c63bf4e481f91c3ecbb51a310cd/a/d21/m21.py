x21