x302