x181