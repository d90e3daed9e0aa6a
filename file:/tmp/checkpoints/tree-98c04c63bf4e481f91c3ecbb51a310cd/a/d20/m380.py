x380