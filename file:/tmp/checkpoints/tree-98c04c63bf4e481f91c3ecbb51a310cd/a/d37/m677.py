x677