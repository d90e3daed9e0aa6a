x25