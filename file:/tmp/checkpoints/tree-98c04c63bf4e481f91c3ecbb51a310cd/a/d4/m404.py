x404