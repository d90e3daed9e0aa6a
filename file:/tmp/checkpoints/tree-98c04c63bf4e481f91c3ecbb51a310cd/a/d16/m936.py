x936