x919