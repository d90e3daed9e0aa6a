x826