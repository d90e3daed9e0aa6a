x138