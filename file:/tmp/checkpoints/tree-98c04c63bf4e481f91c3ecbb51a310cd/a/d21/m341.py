x341