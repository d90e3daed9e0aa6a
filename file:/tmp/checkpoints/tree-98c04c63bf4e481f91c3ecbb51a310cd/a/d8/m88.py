x88