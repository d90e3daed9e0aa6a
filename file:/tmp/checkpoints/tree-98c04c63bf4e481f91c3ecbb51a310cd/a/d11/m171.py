x171