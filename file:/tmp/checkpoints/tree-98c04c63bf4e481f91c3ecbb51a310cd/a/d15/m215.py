x215