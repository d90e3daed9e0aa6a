x153