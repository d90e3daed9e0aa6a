x974