x971