x758