x22