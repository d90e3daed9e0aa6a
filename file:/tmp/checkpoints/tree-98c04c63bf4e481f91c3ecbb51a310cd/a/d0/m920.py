x920