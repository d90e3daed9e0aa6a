x113