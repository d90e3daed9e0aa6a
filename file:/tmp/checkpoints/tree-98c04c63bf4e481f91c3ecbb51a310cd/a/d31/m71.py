x71