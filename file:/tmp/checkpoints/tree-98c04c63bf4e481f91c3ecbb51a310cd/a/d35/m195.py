x195