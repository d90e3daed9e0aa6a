x459