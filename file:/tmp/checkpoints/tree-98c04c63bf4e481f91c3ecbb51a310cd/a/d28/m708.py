x708