x477