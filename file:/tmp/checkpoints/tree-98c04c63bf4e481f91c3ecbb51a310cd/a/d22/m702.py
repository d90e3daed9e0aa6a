x702