x874