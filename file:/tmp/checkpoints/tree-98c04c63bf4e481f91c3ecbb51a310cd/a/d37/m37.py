x37