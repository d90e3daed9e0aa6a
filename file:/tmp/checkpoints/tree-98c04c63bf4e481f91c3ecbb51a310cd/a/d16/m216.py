x216