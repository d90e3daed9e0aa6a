x389