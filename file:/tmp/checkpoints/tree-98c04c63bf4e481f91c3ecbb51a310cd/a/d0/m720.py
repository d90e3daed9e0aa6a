x720