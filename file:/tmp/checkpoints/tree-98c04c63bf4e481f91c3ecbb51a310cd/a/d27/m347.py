x347