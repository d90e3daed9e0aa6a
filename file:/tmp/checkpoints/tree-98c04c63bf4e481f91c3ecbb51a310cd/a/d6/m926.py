x926