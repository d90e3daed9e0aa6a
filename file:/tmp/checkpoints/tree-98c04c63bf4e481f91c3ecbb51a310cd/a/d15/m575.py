x575