x31