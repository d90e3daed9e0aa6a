x285