x779