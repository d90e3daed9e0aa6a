x444