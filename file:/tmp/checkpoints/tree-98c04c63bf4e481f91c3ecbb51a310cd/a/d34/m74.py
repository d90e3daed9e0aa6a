x74