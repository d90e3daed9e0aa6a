x714