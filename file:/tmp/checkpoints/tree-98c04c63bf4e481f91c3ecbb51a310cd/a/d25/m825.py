x825