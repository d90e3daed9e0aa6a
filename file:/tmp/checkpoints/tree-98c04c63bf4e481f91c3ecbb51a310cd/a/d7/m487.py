x487