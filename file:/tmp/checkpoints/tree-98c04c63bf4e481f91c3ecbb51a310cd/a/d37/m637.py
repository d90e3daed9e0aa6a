x637