x988