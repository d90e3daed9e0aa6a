x125