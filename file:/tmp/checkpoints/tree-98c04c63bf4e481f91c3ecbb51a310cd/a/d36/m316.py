x316