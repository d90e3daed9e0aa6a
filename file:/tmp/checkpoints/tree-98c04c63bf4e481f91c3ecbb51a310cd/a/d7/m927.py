x927