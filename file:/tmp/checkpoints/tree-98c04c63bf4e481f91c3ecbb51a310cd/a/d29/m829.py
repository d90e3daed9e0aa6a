x829