x383