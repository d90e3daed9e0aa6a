x611