x399