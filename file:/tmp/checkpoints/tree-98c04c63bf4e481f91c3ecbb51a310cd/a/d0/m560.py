x560