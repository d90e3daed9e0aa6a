x89