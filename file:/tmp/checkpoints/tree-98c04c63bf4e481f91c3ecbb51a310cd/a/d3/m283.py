x283