x832