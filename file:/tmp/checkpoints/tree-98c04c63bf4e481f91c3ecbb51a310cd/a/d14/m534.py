x534