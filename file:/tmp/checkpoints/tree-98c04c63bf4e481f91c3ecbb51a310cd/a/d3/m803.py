x803