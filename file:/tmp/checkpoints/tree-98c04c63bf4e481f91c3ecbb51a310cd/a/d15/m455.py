x455