x311