x228