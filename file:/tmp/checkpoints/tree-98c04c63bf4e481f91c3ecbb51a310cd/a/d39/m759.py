x759