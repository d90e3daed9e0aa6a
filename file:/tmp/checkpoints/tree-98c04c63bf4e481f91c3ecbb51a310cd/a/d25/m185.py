x185