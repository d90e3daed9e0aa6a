x478