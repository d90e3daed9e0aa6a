x655