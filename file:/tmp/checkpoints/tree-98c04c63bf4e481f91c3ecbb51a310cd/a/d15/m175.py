x175