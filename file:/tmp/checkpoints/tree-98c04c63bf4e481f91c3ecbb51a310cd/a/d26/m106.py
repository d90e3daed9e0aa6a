x106