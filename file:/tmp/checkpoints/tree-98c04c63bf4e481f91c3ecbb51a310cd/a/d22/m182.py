x182