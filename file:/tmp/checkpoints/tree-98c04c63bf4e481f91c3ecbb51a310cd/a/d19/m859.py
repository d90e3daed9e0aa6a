x859