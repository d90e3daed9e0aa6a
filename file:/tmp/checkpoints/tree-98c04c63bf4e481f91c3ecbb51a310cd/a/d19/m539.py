x539