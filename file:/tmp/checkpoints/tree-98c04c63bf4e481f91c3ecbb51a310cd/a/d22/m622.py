x622