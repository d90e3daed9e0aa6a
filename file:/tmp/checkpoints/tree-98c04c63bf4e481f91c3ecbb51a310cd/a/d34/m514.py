x514