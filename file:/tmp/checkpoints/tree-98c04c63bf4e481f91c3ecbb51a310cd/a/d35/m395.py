x395