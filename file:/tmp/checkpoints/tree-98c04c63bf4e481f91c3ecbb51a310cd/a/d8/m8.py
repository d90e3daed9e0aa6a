x8