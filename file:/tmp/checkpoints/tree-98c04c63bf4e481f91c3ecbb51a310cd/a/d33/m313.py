x313