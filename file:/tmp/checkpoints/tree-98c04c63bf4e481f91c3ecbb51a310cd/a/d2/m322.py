x322