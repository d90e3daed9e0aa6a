x822