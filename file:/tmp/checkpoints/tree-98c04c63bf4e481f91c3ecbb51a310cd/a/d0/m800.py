x800