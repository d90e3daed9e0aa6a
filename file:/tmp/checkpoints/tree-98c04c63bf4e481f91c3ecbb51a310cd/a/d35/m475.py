x475