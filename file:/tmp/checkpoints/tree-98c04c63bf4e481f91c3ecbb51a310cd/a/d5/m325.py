x325