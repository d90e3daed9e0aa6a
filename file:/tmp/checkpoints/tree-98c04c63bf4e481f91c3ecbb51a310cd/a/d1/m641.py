x641