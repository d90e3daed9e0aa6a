x651