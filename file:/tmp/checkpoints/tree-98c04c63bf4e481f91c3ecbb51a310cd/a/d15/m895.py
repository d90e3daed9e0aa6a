x895