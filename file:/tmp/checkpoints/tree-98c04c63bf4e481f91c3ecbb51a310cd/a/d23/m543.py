x543