x154