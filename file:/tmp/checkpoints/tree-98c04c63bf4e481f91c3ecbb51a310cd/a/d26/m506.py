x506