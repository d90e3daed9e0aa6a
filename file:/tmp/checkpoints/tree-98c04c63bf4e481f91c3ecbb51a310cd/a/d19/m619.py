x619