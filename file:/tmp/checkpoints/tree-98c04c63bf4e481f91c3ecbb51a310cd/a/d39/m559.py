x559