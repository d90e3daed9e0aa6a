x150