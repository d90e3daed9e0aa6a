x17