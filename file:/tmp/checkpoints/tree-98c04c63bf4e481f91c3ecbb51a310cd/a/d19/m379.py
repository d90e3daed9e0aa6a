x379