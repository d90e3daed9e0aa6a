x668