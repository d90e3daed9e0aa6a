x741