x97