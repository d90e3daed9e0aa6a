x740