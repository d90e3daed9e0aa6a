x280