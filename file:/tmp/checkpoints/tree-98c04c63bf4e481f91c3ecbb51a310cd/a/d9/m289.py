x289