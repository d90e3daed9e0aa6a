x111