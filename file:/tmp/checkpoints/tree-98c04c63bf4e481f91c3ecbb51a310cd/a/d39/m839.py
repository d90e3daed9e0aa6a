x839