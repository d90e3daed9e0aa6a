x783