x718