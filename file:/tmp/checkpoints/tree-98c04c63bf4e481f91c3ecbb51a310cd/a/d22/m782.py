x782