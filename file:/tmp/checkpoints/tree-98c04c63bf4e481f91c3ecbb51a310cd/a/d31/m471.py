x471