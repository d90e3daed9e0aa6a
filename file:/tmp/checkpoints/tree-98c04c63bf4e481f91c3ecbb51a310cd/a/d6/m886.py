x886