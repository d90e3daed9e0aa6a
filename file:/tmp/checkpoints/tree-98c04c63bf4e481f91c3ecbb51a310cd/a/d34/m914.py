x914