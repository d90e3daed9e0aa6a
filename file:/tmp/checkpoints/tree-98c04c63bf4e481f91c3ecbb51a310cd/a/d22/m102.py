x102