x639