x997