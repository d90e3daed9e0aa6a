x713