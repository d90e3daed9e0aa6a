x565