x209