x48