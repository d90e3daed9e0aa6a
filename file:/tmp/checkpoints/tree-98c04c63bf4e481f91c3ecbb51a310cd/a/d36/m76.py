x76