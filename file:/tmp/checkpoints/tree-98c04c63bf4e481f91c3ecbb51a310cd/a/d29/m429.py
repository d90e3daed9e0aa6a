x429