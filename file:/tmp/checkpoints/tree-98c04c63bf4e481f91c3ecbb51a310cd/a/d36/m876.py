x876