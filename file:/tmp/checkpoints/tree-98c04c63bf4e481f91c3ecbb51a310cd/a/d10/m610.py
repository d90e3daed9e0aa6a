x610