x836