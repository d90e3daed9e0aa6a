x42