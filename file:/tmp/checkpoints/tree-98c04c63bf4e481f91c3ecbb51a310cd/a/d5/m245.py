x245