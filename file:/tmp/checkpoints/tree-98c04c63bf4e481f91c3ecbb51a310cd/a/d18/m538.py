x538