x956