x618