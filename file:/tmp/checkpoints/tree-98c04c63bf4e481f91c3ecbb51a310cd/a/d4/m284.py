x284