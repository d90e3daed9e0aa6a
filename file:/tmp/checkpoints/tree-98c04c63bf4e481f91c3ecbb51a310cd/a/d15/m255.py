x255