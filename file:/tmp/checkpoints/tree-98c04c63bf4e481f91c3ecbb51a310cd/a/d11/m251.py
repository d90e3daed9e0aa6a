x251