x53