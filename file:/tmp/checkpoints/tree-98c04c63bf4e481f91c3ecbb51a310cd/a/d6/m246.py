x246