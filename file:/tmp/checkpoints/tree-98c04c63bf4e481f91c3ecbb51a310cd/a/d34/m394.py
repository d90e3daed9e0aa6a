x394