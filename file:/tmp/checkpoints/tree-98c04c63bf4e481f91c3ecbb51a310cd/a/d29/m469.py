x469