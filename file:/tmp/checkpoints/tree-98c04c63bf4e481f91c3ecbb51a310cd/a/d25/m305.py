x305