x180