x815