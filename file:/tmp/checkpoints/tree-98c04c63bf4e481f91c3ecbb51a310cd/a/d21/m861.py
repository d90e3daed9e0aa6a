x861