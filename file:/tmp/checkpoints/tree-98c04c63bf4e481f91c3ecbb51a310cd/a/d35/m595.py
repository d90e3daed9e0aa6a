x595