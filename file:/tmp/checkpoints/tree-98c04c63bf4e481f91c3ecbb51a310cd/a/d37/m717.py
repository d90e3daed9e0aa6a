x717