x353