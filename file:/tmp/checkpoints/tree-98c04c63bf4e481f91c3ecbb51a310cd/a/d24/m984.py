x984