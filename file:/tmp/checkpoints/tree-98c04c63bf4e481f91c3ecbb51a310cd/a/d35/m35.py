x35