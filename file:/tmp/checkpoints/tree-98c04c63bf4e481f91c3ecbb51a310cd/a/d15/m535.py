x535