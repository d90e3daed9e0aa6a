x722