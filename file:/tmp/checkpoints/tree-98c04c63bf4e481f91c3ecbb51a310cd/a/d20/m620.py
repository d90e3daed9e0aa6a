x620