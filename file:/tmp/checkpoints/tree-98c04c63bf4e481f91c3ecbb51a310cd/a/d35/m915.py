x915