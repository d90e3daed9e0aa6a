x672