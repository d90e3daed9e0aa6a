x583