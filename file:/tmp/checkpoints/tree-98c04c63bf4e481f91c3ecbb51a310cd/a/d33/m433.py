x433