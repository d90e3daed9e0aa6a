x679