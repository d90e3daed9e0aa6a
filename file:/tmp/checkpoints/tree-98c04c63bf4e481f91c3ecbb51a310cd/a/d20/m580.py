x580