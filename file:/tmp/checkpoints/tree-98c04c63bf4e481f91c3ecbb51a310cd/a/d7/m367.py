x367