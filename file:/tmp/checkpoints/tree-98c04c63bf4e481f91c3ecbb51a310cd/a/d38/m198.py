x198