x561