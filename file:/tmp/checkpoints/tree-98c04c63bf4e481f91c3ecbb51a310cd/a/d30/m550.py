x550