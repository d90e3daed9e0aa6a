x627