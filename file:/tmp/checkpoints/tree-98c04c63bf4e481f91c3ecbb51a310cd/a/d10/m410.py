x410