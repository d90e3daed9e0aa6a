x337