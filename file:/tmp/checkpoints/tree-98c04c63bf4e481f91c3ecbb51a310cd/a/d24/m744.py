x744