x94