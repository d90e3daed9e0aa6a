x460