x809