x221