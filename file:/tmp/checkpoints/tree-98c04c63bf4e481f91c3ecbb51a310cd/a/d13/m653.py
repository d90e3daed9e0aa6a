x653