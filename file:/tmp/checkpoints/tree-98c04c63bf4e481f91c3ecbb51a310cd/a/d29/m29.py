x29