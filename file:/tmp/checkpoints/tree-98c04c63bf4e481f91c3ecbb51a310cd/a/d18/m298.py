x298