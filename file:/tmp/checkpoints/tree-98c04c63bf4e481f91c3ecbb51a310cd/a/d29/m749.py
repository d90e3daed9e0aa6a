x749