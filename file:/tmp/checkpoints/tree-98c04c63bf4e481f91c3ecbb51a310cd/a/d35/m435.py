x435