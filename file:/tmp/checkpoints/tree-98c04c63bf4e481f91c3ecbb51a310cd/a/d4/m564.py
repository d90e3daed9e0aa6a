x564