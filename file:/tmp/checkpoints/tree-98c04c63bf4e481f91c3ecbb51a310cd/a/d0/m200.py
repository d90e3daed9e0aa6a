x200