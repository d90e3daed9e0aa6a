x314