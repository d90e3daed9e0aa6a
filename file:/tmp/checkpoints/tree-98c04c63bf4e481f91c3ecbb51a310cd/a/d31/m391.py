x391