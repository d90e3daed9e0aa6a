x260