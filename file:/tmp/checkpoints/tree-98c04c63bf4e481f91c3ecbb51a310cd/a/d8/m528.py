x528