x930