x961