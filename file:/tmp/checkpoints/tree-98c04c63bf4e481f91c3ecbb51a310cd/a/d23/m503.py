x503