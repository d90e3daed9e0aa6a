x303