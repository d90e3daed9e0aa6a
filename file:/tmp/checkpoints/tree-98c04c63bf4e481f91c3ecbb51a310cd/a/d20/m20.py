x20