x697