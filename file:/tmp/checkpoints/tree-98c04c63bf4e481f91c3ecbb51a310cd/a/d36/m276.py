x276