x890