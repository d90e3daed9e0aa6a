x736