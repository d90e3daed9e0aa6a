x187