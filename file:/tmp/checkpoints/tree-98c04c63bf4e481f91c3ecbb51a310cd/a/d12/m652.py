x652