x192