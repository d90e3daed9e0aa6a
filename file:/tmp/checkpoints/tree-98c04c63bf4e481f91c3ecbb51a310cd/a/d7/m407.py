x407