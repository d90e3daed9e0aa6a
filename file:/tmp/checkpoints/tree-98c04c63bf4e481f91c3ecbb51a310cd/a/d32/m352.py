x352