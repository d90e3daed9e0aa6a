x958