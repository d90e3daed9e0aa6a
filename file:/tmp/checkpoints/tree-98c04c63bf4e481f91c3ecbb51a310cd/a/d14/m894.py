x894