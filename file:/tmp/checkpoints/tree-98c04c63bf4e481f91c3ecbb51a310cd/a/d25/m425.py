x425