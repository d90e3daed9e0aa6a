x219