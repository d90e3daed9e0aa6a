x309