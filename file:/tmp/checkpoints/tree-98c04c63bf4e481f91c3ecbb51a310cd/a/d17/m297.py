x297