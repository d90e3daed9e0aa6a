x91