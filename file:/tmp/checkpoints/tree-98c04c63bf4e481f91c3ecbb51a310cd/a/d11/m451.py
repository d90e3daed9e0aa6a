x451