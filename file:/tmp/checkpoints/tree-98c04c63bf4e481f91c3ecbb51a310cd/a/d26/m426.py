x426