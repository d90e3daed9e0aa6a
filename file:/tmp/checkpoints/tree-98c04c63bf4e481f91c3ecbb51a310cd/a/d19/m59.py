x59