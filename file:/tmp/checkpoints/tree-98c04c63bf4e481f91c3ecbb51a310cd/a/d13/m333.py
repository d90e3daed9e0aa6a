x333