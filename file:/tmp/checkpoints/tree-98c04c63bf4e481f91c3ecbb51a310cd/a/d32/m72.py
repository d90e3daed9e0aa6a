x72