x11