x365