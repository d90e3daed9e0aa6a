x605