x541