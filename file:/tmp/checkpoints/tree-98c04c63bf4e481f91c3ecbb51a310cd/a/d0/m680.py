x680