x563