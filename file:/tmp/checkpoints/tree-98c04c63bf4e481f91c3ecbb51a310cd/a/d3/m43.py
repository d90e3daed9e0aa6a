x43