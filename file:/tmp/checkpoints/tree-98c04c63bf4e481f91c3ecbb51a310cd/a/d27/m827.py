x827