x490