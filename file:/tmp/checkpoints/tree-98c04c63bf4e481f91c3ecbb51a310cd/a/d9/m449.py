x449