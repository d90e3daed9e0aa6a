x878