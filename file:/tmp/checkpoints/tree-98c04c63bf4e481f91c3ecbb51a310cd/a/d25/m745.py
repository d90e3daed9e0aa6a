x745