x831