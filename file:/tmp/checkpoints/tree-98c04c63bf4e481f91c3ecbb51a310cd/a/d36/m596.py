x596