x121