x83