x254