x103