x324