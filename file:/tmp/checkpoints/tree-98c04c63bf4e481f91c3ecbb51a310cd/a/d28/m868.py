x868