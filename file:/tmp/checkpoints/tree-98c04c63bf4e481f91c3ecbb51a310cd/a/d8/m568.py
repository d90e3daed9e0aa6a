x568