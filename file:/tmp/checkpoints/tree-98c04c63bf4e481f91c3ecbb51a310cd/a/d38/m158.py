x158