x371