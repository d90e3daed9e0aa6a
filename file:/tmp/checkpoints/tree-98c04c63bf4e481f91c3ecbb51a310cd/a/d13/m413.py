x413