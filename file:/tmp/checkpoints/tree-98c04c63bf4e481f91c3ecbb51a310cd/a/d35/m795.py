x795