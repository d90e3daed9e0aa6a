x555