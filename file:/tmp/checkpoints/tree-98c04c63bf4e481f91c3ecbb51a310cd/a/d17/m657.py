x657