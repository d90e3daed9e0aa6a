x748