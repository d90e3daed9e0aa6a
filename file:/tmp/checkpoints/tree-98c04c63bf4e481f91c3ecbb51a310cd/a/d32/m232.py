x232