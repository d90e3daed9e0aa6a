x163