x623