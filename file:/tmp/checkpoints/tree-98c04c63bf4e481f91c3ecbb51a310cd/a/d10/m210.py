x210