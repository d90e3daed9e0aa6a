x549