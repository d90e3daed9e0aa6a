x699