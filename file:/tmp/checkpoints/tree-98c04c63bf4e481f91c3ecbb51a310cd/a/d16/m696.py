x696