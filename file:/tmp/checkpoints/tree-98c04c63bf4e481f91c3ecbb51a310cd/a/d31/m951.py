x951