x465