x388