x133