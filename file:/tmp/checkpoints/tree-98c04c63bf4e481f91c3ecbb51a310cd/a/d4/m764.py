x764