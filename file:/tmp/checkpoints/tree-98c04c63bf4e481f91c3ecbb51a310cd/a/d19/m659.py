x659