x55