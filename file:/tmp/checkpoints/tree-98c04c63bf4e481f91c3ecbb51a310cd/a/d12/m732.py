x732