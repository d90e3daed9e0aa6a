x49