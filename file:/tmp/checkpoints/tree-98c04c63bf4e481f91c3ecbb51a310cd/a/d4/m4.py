x4