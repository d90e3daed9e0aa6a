x684