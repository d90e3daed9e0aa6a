x377