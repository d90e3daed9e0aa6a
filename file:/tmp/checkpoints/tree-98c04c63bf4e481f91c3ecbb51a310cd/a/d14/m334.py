x334