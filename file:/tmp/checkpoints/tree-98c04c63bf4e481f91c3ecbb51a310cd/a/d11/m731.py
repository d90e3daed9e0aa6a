x731