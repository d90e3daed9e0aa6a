x975