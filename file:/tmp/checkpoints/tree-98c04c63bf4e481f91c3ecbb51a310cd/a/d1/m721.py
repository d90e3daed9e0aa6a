x721