x135