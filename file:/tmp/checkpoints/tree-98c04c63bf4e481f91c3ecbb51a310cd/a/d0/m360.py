x360