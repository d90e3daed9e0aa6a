x574