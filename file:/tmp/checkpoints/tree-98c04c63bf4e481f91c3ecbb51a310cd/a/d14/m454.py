x454