x979