x780