x614