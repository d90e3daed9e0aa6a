x727