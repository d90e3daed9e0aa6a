x168