x474