x959