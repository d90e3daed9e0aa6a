x223