x554