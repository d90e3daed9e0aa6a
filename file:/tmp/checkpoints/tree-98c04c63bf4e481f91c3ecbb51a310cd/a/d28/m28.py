x28