x281