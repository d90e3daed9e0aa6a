x351