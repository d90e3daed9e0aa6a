x848