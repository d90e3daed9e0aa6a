x571