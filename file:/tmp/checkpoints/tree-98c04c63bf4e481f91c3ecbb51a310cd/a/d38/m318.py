x318