x633