x108