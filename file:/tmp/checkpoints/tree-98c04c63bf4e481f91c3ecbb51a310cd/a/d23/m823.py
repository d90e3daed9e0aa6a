x823