x669