x6