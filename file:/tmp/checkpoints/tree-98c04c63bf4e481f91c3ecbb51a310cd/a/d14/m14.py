x14