x416