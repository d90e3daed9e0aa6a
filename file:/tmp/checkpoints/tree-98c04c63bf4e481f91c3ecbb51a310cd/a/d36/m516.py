x516