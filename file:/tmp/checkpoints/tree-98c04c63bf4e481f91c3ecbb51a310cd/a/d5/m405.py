x405