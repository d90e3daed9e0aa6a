x339