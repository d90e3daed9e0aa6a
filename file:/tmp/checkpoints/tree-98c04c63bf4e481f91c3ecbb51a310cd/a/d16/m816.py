x816