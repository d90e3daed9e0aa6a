x546