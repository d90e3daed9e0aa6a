x931