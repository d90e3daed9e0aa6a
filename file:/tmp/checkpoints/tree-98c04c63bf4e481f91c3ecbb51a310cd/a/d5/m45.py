x45