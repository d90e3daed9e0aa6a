x880