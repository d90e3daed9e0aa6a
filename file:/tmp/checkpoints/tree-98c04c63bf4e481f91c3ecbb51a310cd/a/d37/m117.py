x117