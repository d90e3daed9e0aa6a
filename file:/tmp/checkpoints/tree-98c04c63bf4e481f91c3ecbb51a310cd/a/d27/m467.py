x467