x12