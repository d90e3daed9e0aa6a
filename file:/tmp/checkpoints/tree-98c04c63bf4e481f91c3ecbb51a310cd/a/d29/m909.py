x909