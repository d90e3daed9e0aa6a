x510