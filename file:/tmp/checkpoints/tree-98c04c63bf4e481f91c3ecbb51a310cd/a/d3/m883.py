x883