x767