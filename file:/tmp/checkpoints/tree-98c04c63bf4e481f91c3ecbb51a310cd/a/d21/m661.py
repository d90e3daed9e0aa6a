x661