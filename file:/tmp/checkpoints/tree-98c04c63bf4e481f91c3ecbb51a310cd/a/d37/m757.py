x757