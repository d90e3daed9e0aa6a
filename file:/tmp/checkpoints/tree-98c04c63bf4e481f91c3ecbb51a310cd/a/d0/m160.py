x160