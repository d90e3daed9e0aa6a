x291