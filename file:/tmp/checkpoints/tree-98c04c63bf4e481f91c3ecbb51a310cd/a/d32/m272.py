x272