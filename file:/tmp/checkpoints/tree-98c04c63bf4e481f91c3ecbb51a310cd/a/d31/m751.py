x751