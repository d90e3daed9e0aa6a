x166