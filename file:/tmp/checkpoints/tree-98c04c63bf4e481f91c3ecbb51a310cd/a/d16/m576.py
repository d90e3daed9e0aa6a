x576