x92