x658