x949