x390