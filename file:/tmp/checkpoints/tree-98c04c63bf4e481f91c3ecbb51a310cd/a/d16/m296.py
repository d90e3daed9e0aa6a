x296