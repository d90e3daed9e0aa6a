x229