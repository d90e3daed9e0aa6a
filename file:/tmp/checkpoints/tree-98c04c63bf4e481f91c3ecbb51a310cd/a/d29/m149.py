x149