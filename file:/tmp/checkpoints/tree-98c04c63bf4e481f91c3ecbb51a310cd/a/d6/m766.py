x766