x452