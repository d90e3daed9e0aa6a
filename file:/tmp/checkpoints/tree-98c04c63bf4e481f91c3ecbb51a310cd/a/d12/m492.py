x492