x13