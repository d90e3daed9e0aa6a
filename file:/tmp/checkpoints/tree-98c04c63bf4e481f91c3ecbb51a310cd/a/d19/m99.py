x99