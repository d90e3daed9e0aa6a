x952