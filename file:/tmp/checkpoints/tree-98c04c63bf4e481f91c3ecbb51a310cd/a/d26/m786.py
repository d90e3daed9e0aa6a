x786