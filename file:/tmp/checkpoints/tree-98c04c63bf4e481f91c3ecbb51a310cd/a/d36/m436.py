x436