x648