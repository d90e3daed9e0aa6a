x629