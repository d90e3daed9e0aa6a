x805