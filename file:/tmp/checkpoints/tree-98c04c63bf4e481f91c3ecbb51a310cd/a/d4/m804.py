x804