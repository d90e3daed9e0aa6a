x424