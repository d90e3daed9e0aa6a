x964