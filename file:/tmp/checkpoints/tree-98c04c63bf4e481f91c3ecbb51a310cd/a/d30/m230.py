x230