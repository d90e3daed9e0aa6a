x552