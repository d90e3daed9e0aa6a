x811