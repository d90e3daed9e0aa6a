x774