x242