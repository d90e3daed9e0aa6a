x853