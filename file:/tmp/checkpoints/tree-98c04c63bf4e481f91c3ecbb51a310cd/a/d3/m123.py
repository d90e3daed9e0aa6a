x123