x572