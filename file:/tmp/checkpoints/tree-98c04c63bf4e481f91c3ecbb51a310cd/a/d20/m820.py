x820