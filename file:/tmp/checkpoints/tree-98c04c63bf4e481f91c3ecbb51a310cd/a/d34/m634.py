x634