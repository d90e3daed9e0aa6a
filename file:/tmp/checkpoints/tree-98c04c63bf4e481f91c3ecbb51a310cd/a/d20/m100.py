x100