x977