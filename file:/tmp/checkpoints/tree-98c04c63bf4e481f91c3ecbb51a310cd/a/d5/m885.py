x885