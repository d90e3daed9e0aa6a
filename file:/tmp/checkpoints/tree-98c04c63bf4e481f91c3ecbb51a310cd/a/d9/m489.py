x489