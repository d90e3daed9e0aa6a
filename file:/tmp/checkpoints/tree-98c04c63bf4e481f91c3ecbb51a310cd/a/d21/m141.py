x141