x730