x650