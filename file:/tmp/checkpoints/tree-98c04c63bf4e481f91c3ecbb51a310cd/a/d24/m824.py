x824