x905