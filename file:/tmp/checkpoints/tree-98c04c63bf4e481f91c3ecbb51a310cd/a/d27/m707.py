x707