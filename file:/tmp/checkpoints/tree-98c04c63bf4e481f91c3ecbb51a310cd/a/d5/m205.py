x205