x259