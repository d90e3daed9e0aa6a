x401