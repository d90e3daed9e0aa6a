x877