x765