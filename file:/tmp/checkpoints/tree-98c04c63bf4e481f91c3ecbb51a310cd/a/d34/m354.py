x354