x54