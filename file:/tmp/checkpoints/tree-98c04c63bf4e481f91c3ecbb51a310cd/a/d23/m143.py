x143