x287