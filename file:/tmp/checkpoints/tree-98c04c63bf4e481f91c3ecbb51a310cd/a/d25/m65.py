x65