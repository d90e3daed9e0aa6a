x417