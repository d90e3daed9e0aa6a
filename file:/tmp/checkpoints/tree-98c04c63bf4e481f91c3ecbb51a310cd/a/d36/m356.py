x356