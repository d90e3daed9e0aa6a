x981