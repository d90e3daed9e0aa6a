x497