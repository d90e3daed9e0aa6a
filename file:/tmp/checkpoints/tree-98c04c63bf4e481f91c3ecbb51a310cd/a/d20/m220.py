x220