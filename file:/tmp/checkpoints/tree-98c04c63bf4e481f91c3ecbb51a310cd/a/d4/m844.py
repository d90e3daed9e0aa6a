x844