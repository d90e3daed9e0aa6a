x326