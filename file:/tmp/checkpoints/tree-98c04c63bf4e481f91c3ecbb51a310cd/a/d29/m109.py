x109