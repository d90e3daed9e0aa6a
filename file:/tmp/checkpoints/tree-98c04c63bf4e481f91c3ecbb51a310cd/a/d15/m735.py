x735