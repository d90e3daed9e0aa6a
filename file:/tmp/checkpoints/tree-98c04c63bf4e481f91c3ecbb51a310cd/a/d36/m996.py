x996