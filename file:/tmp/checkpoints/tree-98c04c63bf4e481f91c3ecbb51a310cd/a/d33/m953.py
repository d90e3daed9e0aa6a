x953