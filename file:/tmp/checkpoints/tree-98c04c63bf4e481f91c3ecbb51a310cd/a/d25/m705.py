x705