x793