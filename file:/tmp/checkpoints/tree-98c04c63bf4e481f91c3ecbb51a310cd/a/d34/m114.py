x114