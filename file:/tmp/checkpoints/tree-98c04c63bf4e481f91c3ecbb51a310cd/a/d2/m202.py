x202