x556