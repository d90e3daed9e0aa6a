x412