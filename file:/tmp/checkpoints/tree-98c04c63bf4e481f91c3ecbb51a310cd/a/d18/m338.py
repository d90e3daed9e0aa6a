x338