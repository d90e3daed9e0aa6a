x41