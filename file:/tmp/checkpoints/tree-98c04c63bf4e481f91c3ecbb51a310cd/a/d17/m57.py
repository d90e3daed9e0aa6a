x57