x145