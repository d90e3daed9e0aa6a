x247