x817