x967