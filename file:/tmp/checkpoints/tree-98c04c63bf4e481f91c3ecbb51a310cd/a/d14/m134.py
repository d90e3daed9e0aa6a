x134