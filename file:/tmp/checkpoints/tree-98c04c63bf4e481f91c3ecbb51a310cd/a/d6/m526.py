x526