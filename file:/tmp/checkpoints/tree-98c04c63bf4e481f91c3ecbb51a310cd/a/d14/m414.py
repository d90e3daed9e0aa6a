x414