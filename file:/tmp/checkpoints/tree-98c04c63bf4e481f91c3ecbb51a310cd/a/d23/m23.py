x23