x654