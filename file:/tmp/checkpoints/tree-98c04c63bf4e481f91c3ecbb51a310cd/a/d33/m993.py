x993