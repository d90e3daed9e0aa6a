x733