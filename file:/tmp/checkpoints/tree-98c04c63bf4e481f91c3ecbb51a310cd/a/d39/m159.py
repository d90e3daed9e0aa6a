x159