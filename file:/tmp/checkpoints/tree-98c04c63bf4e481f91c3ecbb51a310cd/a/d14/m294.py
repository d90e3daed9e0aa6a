x294