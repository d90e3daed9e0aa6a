x863