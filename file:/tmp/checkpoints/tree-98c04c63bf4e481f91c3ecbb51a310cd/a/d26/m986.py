x986