x139