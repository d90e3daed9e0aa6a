x332