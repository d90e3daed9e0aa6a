x95