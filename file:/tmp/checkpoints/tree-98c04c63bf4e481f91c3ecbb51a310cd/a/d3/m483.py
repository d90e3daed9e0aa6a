x483