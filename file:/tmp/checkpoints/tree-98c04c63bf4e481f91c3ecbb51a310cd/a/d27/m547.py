x547