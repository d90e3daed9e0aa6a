x643