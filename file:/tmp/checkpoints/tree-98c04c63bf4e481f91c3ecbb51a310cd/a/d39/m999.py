x999