x592