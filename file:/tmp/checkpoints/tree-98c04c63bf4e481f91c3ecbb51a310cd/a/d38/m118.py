x118