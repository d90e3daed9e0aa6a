x833