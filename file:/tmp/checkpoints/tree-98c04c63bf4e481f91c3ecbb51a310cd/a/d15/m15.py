x15