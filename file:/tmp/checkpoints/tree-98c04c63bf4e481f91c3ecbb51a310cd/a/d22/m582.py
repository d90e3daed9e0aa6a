x582