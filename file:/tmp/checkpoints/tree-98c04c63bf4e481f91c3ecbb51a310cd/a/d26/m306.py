x306