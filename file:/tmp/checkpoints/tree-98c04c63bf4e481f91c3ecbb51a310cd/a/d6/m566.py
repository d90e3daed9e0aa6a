x566