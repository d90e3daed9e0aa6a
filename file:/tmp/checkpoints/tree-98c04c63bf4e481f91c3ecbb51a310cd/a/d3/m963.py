x963