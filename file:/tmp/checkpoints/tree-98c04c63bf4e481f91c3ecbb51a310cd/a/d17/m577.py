x577