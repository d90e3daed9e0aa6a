x261