x363