x520