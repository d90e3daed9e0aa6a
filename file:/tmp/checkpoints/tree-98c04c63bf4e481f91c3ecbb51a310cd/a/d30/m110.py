x110