x101