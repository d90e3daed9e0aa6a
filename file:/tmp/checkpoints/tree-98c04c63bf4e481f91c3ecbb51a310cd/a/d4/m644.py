x644