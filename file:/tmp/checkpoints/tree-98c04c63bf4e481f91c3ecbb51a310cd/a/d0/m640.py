x640