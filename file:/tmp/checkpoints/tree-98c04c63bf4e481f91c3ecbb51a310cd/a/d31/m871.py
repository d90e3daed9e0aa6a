x871