x96