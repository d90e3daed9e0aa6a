x771