x992