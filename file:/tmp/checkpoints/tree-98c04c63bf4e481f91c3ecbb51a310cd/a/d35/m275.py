x275