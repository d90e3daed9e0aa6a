x693