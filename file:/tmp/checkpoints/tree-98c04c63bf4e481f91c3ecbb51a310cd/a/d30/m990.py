x990