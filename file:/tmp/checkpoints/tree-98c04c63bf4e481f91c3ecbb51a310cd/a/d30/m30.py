x30