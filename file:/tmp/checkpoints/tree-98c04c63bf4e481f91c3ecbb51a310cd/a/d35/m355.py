x355