x439