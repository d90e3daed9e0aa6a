x819