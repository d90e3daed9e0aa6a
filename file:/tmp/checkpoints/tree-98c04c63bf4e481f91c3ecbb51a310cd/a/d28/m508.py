x508