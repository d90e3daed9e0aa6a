x214