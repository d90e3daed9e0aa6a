x500