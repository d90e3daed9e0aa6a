x973