x197