x241