x225