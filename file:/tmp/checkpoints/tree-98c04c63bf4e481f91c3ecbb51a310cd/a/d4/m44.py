x44