x567