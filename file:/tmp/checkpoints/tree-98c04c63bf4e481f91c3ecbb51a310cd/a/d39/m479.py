x479