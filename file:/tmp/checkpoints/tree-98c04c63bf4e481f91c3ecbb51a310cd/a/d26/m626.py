x626