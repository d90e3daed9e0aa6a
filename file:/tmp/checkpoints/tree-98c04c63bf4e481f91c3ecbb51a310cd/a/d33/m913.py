x913