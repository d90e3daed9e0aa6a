x137