x911