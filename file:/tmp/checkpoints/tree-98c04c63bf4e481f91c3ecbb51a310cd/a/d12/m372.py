x372