x107