x112