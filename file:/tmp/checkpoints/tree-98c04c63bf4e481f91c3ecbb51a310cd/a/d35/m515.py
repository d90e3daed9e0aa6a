x515