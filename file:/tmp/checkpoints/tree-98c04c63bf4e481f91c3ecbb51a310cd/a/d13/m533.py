x533