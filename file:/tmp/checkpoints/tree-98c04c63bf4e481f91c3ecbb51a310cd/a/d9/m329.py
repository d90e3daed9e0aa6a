x329