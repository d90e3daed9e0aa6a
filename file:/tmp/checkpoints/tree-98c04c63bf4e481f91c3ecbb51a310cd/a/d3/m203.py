x203