x784