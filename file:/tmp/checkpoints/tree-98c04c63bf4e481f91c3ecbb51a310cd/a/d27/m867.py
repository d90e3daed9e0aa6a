x867