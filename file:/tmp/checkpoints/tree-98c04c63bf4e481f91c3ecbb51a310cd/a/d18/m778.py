x778