x56