x511