x87