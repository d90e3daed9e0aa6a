x19