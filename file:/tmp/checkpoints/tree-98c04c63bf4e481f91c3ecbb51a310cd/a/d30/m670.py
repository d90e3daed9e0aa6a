x670