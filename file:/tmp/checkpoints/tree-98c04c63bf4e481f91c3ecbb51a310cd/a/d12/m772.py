x772