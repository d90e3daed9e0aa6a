x879