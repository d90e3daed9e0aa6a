x46