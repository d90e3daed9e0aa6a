x174