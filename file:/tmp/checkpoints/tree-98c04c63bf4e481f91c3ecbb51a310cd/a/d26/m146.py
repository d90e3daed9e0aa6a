x146