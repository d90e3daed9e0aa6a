x39