x666