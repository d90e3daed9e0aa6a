x98