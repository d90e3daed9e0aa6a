x788