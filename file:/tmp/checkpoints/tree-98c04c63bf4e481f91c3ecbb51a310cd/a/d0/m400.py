x400