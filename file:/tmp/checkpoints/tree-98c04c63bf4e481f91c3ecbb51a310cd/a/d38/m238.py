x238