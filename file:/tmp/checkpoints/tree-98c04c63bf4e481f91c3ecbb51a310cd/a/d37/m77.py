x77