x213