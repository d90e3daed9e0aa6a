x85